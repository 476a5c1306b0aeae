"""lexloom: text analytics for document corpora as Spark DataFrame operators."""
