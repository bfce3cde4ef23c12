"""Linting documents as they arrive."""
