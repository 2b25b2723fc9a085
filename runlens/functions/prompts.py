"""Prompt templates and instruction suffixes of the eight prompting approaches.

Fixed values: the texts below must equal the reference templates for rendered
prompts to be identical; ``{question}`` is the only placeholder.
"""
# --- fixed values: templates, by approach -----------------------------------
TEMPLATES: dict[str, str] = {}

TEMPLATES['None'] = 'You are an AI assistant helping with reasoning tasks.\n\nPlease analyze the following question carefully and provide a thoughtful response.\n\nQuestion: {question}\n\nYour response should be clear, accurate, and well-reasoned.\n'

TEMPLATES['ChainOfThought'] = 'You are an AI assistant that excels at step-by-step reasoning.\n\nPlease analyze the following question carefully and think through it step by step. Break down your reasoning process into clear, logical steps before providing your final answer.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. First, identify what the question is asking\n2. Break down the problem into smaller parts\n3. Work through each part step by step\n4. Combine your findings to reach a conclusion\n5. State your final answer clearly\n\nRemember to show your reasoning process explicitly - this helps ensure accuracy and allows others to follow your logic.\n'

TEMPLATES['ProgramOfThought'] = 'You are an AI assistant that excels at solving problems by writing and executing code.\n\nFor the following question, please think programmatically and write code to solve it step by step. Use Python code to break down the problem, perform calculations, and arrive at the solution.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. First, understand what the question is asking\n2. Break down the problem into computational steps\n3. Write Python code to solve each step\n4. Execute the logic mentally or show the expected output\n5. Provide your final answer based on the code results\n\nUse clear variable names, add comments to your code, and show your thinking process. If the problem involves calculations, data manipulation, or logical operations, demonstrate how code can solve it systematically.\n\nFormat your code in clear code blocks and explain what each section does.\n'

TEMPLATES['AsPlanning'] = 'You are an AI assistant that excels at strategic planning and goal-oriented problem solving.\n\nPlease approach the following question by treating it as a planning problem. Develop a systematic plan to achieve the goal, breaking it down into actionable steps and considering potential obstacles.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. Goal Analysis: Clearly define what needs to be achieved\n2. Planning Phase: Break down the goal into sub-goals and milestones\n3. Action Sequence: Develop a step-by-step plan with dependencies\n4. Risk Assessment: Identify potential obstacles and mitigation strategies\n5. Execution Strategy: Outline how to implement the plan effectively\n6. Final Answer: Provide your solution based on the planned approach\n\nRemember to think strategically - consider both immediate actions and longer-term implications. Your plan should be practical, achievable, and account for potential challenges.\n'

TEMPLATES['Reflection'] = 'You are an AI assistant that excels at reflective reasoning and self-correction.\n\nPlease approach the following question by first providing an initial response, then reflecting on that response to identify potential issues, improvements, or alternative perspectives, and finally providing a refined answer.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n\n**Initial Response:**\nProvide your first attempt at answering the question.\n\n**Reflection:**\nNow, let me reflect on my initial response:\n- What assumptions did I make?\n- Are there any potential errors or oversights?\n- What alternative approaches or perspectives should I consider?\n- How could my reasoning be improved?\n\n**Refined Response:**\nBased on my reflection, here is my improved answer:\n\nThis reflective approach helps ensure more accurate and well-considered responses by incorporating self-criticism and iterative improvement.\n'

TEMPLATES['ChainOfVerification'] = 'You are an AI assistant that excels at systematic verification and accuracy checking.\n\nPlease approach the following question using a Chain-of-Verification methodology. Generate an initial answer, then create verification questions to check your reasoning, and finally provide a refined response.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. Initial Response: Provide your first answer to the question\n2. Verification Questions: Generate 3-5 specific questions to verify your answer\n3. Verification Analysis: Answer each verification question systematically\n4. Accuracy Assessment: Evaluate the reliability of your initial response\n5. Refined Response: Provide an improved answer based on verification\n6. Final Answer: State your most accurate conclusion\n\nRemember to be thorough in your verification - question your assumptions, check for logical consistency, and consider alternative perspectives. This helps ensure accuracy and builds confidence in your final answer.\n'

TEMPLATES['SkeletonOfThought'] = 'You are an AI assistant that excels at structured thinking through outline-based reasoning.\n\nPlease approach the following question using a Skeleton-of-Thought methodology. Start with a high-level outline, then progressively expand each section with detailed reasoning.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. Skeleton Outline: Create a high-level outline of your reasoning approach\n2. Section Expansion: Expand each outline section with detailed analysis\n3. Progressive Development: Build upon each section systematically\n4. Integration: Connect all sections into a coherent whole\n5. Refinement: Polish and improve the overall reasoning\n6. Final Answer: Present your comprehensive conclusion\n\nRemember to think hierarchically - start with the big picture structure, then fill in the details. This systematic approach helps ensure completeness and logical flow in your reasoning.\n'

TEMPLATES['TreeOfThought'] = 'You are an AI assistant that excels at exploring multiple reasoning paths and evaluating alternatives.\n\nPlease approach the following question using a Tree-of-Thought methodology. Generate multiple reasoning branches, evaluate each path, and select the best approach.\n\nQuestion: {question}\n\nPlease structure your response as follows:\n1. Problem Decomposition: Break down the question into key components\n2. Reasoning Branches: Generate 3-4 different approaches or reasoning paths\n3. Branch Exploration: Develop each reasoning branch in detail\n4. Path Evaluation: Assess the strengths and weaknesses of each branch\n5. Branch Selection: Choose the most promising reasoning path(s)\n6. Synthesis: Combine insights from the best branches\n7. Final Answer: Present your conclusion based on the optimal reasoning path\n\nRemember to think divergently first - explore multiple possibilities before converging on the best solution. This systematic exploration helps ensure you consider the strongest possible reasoning path.\n'

# --- fixed values: instruction suffixes; other approaches use 'none' --------
SUFFIXES: dict[str, str] = {
    'none': '\nProvide your complete response and the final answer value separately.\n',
    'chainofthought': '\nThink through this step by step. Count your reasoning steps and note if you use numbered steps.\nProvide your complete reasoning and the final answer value separately.\n',
    'treeofthought': '\nExplore multiple reasoning paths. Indicate how many branches you explored and which one you selected.\nProvide your complete reasoning and the final answer value separately.\n',
    'programofthought': '\nUse computational thinking. Include any code or calculations in your reasoning.\nProvide your complete reasoning and the final answer value separately.\n',
    'reflection': '\nReflect on your reasoning process. Make corrections if needed and count your reflection iterations.\nProvide your complete reasoning and the final answer value separately.\n',
    'chainofverification': '\nVerify your reasoning with additional steps. Count your verification steps.\nProvide your complete reasoning and the final answer value separately.\n',
}


def suffix_for(approach: str) -> str:
    return SUFFIXES.get(approach.lower(), SUFFIXES["none"])
