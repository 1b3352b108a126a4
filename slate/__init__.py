"""slate: schedules, head-to-head results and their statistics as Spark DataFrame operators."""
