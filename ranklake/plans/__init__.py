"""Whole plans: builds, read views and registered queries."""
