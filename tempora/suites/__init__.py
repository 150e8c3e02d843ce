"""Registered queries by area; importing a module registers its queries."""
