"""Fixture views, registered queries and experiment arms."""
