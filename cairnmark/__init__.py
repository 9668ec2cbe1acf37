"""Media-catalogue analytics and corpus preparation as Spark DataFrame jobs."""
