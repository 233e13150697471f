"""Ledgers and folds over ordered events."""
