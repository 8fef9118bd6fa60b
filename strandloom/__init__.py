"""Spark jobs for genomics and omics tables."""
