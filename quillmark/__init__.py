"""Exam grading as Spark jobs: author, ingest, align, score, calibrate, report."""
