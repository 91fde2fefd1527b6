"""Analyses over text-typed tables: profile, checks, drift, repair, impact."""
