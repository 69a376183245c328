"""Whole analyses: tables of breaks, findings and verdicts from tables of documents."""
