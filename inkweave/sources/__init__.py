"""Readers for captured pages, requests, order lists, Markdown folders and artifact listings."""
