"""bitloom: byte, bit, context and code-length statistics over text corpora as Spark plans."""
