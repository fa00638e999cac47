"""segno: note-event analytics on Spark DataFrames."""
