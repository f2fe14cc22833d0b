"""Message-defence analytics as Spark jobs."""
