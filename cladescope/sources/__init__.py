"""Readers and writers of the workflow's file formats."""
