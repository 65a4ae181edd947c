"""Finding, subsetting and preparing environmental observations as Spark jobs.

Every function takes DataFrames or Columns and returns DataFrames or Columns; nothing
here keeps state, talks to a network or runs Python code per row.
"""
