"""tidewire: news-wire analytics expressed as PySpark DataFrame plans."""
