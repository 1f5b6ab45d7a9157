"""Readers and writers of reads, sheets, run information and reports."""
