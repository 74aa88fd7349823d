"""Whole jobs: captured pages and job rows in, corpus tables out."""
