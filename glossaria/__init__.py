"""Glossaria: text-evidence analytics as pure DataFrame operators on PySpark."""
