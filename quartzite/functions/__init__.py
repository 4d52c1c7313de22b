"""Part of quartzite."""
