"""Flows, macros and registered queries."""
