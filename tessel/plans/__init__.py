"""From syntax trees to results: the per-document interpreter and the lowering to DataFrames."""
