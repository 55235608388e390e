"""marginalia: a note-corpus query engine on PySpark DataFrames."""
