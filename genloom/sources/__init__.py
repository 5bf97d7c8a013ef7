"""Readers and writers for the text, matrix and haplotype formats."""
