"""Change logs and the streams that follow them."""
