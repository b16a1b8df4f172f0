"""Map-crossing analytics as Spark DataFrame jobs: many maps at once, one shuffle key."""
