"""The query language: text to a plan, a plan to a DataFrame."""
