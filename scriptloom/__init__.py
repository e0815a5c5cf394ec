"""scriptloom: transcript-corpus analytics expressed as Spark DataFrame plans."""
