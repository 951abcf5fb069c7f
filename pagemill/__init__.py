"""Document dataset engine on PySpark: documents to cells, chunks, search, samples and exports."""
