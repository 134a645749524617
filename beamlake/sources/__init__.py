"""Readers of point clouds, messages and poses, and writers of results."""
