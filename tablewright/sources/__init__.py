"""CSV scan and inference, sinks, and the shared scratch folder."""
