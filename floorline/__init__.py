"""floorline: conversational-timeline analytics expressed as Spark DataFrame plans."""
