"""Part of dqengine."""
