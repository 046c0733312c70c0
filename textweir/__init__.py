"""textweir: corpus-scale text localisation analytics as ordinary Spark queries."""
