"""Reading what a load needs and writing what it makes."""
