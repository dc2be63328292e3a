"""Whole analyses: each is one lazy plan over all samples."""
