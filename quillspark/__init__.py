"""quillspark: text-alignment analytics and evaluation on PySpark DataFrames."""
