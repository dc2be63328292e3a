"""Readers: text formats become typed tables; parsing is column expressions over ``spark.read.text`` rows."""
