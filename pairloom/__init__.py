"""Pairwise link analytics on Spark: nested records in, labelled and modelled entity pairs out."""
