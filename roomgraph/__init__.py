"""Room graphs and device frame streams on Spark."""
