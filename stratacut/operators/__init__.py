"""Steps over pixel, mask, run and contour tables."""
