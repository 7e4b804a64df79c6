"""gneiss: document analytics, retrieval and retrieval evaluation on Spark DataFrames."""
