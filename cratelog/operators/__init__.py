"""Catalogue, manifest, segmentation, loop, vocal, symbolic, spectral and export operators on DataFrames."""
