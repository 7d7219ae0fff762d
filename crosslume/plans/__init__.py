from crosslume.plans.run import Results, run_files, run_pipeline, save_results

__all__ = ["Results", "run_files", "run_pipeline", "save_results"]
