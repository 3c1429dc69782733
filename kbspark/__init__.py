"""kbspark: knowledge bases from threads and pages, as Spark DataFrame plans."""
