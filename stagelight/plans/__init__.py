"""Plans: analysis frames, analyses, the registered query catalogue and its oracle."""
