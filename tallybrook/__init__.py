"""Message-stream state engine and corpus tools built on PySpark DataFrames."""
