"""Part of ramify."""
