"""Analytics on assay, survey and raster tables as Spark DataFrames."""
