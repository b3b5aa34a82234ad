"""Runnable queries by family. Importing the package registers them."""
