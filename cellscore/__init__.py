"""cellscore: scoring of gridded land/water answers as Spark DataFrame jobs."""
