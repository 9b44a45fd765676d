"""larder: food-composition analytics and corpus operations on Spark."""
