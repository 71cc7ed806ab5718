"""Readers and writers of the file formats around k-mer phylogenetics."""
