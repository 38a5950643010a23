"""Readers and writers of panels."""
