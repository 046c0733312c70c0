"""The queries of the library; each module registers its own."""
