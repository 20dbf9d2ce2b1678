"""colloquy: transcript and corpus analytics as Spark DataFrame jobs."""
