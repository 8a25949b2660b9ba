"""Readers and writers of files and embedded databases."""
