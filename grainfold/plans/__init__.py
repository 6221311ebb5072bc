"""Recipes, work units and their scheduling."""
