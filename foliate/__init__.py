"""Documents, workbooks and macro projects as DataFrames."""
