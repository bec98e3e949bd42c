"""Readers and writers: task inputs, files, run history."""
