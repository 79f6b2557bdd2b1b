"""Multi-step jobs: feature-set versions, training, scoring, tuning, updating."""
