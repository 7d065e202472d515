"""Arborscale: a PySpark-native analytics engine for city tree inventories."""
