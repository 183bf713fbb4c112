"""Relational building blocks shared by the plans (dedupe, as-of, EWM, islands, ...)."""
