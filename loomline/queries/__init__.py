"""Registered queries by area, each with the SQL that says the same where SQL can."""
