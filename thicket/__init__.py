"""Robust multi-output decision forests, imputation and forest analytics on Spark DataFrames."""
