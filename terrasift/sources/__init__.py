"""Where points, cells and samples come from and go to."""
