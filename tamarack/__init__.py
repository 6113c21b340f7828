"""Tamarack: question-answering dataset engineering on Spark DataFrames."""
