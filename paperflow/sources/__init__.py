"""Where records come from and go to."""
