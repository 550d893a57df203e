"""lamina: volumetric, surface and corpus analytics on Spark DataFrames."""
