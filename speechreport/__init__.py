"""Spark jobs that turn tables and streams of dictated recordings into reports."""
