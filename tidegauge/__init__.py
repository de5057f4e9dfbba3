"""Network flow telemetry analytics as DataFrame transforms, for batch and Structured Streaming alike."""
