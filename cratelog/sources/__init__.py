"""Audio files as tables, and tables as audio files."""
