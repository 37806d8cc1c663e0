"""Multi-step plans with fitted state."""
