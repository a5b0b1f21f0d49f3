"""quillgrid: spreadsheet-style computation on Spark DataFrames."""
