"""Jobs that compose the operators over the layers of a lake."""
