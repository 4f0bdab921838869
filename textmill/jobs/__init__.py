"""Thin command lines, for ``spark-submit textmill/jobs/<name>.py``; they only wire operators."""
