"""DataFrame -> DataFrame operators (no actions inside, except where a
function is documented to return a driver-side value)."""
