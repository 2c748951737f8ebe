"""Structured Streaming operators; ``run`` drives one to the end of what is there."""
