"""The batch steps on Structured Streaming inputs."""
